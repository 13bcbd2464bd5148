"""DataFrame operators: detect, chunk, vault, mask, restore, review, conversation, report."""
