"""Column classes, fixed word lists and scalar text / number functions."""
