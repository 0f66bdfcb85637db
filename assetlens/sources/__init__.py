"""Where snapshots and tables come from."""
