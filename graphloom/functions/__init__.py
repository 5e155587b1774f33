"""Functions of graphloom."""
