"""Jobs on bars that arrive over time."""
