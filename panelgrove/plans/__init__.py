"""Named factors and jobs built from the operators."""
