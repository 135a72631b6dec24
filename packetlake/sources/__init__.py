"""Readers and writers for captures, packet tables, topology files and exports."""
