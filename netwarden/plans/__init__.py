"""Building blocks that keep jobs balanced, and the stand-in input views."""
