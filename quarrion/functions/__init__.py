"""See the README for the operator index."""
