"""Writers: load modes, snapshot logs and report extracts."""
