"""Plans: index building, address resolution, directory, quality gates."""
