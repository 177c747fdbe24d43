"""Readers of sensor logs and calibration files, and writers of results."""
