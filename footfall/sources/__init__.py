"""Where hits come from and where they are kept."""
