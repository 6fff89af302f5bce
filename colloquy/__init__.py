"""Colloquy: conversation analytics as Spark DataFrame programs."""
