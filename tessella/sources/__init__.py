"""Readers, writers and generators of matrices and tensors."""
