"""Named plans over the star-schema and trace tables."""
