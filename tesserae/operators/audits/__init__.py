"""Similarity audits. Each gives exact, near, candidate and family relations; near pairs are never closed transitively."""
