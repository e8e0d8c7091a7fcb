"""Small column and window helpers shared by the operators."""
