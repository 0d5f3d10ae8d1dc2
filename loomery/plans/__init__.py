"""From specifications and profiles to DataFrames."""
