"""Conversation, catalogue and embedding analytics as Spark DataFrame operators."""
