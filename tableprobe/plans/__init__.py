"""Wiring of the operators into whole reports."""
