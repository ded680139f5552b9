"""Report analytics and corpus processing, expressed as DataFrame transforms."""
