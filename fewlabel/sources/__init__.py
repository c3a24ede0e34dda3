"""Readers and writers: TSV / CSV / JSON example tables, augmentation folders, feature cache."""
