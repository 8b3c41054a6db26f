"""Marlstone: batch jobs for signal research and text corpora on Spark."""
