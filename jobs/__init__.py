"""Runnable jobs: each has a command line and a small configuration."""
