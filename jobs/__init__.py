"""Runnable jobs: each a function taking a session, a command line and a small configuration file."""
