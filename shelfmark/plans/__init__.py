"""The user-level jobs, composed of operators."""
