"""Part of cellsift."""
