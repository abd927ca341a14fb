"""Whole plans composed of operators: id assignment, basic graph patterns."""
