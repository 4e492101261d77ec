"""Column expressions shared by the jobs. Everything here returns a Column."""
