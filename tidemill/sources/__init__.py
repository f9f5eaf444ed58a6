"""Stored tables of points and readers of older file formats."""
