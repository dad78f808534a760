"""Readers and writers for captures, datagrams, lists and guide documents."""
