"""Column functions and the small numeric helper behind the rating fit."""
