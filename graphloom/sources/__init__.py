"""Where entities come from and where intermediate tables go."""
