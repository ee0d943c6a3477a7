"""Jobs that turn landed files and log lines into typed rows."""
