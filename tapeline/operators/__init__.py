"""Analytical operators over bars, trades, ledgers and chains."""
