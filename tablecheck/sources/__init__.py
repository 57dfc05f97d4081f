"""Readers, sniffers and writers."""
