"""Windowed monitoring and row rules, over tables and over streams alike."""
