"""Conversation-memory analytics as PySpark DataFrame programs."""
