"""Where rows come from and go to: landing folders, the tier store, JSON."""
