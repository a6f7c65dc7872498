"""Where programs come from and datasets go to."""
