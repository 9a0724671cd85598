"""Readers and writers of image, label and gold tables."""
