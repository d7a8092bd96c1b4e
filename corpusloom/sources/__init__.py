"""Readers: folders of mixed files, records, conversations and tables into typed DataFrames."""
