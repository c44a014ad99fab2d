"""Where panels come from and where factors are kept."""
