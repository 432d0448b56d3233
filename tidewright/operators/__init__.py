"""Relational operators over panels of (Ticker, Date) rows."""
