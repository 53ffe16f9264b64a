"""Compiled signal plans: definitions of messages and signals, and the column expressions they stand for."""
