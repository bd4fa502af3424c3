"""netweave: ordered IP-network overlays on Spark DataFrames.

The package resolves ordered logs of network inserts into disjoint CIDR
leaves, joins them to tables of addresses, and reads and writes the public
MaxMind DB (MMDB) file format.
"""

__version__ = "0.1.0"
