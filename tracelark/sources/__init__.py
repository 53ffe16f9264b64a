"""Readers: trace recordings (ASC, TRC, BLF, MF4) to frame tables, signal databases (DBC) to compiled messages."""
