"""DataFrame operators: fragments, overlaps, bins, ploidy, segmentation, copy calling, clustering."""
