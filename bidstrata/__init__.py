"""Bid-book analytics on Spark: offers, rebids, bid curves and market outcomes as DataFrame operators."""
