"""Plans that chain operators from input tables to reports."""
