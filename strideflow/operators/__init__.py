"""Set-oriented operators: segmentation, clustering, features."""
