"""Composed preparations and reports."""
