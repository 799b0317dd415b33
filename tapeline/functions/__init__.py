"""Column functions: clocks and prices."""
