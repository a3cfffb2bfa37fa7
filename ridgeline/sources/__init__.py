"""Readers, writers and seeded inputs."""
