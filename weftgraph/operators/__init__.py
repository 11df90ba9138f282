"""Graph operators as DataFrame functions."""
