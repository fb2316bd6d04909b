"""Readers and writers of model containers and dumps."""
