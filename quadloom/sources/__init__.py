"""quadloom.sources"""
