"""The dialect is for batches: nothing here reads or writes streams."""
