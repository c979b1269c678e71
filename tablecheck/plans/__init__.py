"""Reports over results and the end-to-end audit."""
