"""Plans: compositions of sources and operators that users call."""
