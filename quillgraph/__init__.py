"""Citation-network analytics as DataFrame programs."""
