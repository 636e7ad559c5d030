"""The same networks over unbounded tables."""
