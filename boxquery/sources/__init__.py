"""Reading and writing point files, generated points and saved indexes."""
