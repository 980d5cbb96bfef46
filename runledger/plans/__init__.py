"""Plans: sessions and their lifecycle, reports, and the catalogue of queries."""
