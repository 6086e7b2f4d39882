"""Packet, event, knowledge and evaluation analytics as PySpark DataFrame operators."""
