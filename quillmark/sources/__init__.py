"""Where tenders, rules and corpora come from."""
