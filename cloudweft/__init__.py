"""Jobs for large collections of point clouds and labelled text, as plain DataFrame functions."""
