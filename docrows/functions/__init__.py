"""Column functions: text, numbers, dates, headers and cell grids."""
