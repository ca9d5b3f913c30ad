"""Whole queries, each as DataFrame code and as SQL."""
