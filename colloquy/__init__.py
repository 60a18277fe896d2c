"""Conversation analytics on Spark: captures, sessions, messages, search and quality jobs as DataFrames."""
