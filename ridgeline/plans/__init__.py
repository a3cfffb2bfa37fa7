"""Operators put together: reports, the run, registered queries."""
