"""Jobs composed of several operators, including bounded round loops."""
