"""Streaming twins of the batch operators; each gives the batch result on replay."""
