"""Incremental counting of newly arrived sequences."""
