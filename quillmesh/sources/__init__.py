"""quillmesh.sources"""
