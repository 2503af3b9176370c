"""Column builders: masked-value rules, band algebra, geometry, colour."""
