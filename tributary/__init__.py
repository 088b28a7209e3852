"""Tributary: three-way merge analytics on Spark DataFrames."""
