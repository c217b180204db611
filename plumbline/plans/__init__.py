"""Whole queries over tables and over repositories."""
