"""Scans of raw input and writes of snapshots and logs."""
