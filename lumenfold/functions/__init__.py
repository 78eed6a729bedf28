"""Column expressions: colours, per-pixel projections, masks, vector arithmetic and nearest centers."""
