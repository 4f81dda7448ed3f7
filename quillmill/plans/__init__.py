"""Compiled queries, and the control plane that decides which to run."""
