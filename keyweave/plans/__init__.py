"""Query texts, and how joins are laid out."""
