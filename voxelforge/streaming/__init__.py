"""No stream operators: every operator of this engine works on bounded tables."""
